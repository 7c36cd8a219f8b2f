"""Spark-native masking, masked-copy synchronisation and transfer auditing."""
