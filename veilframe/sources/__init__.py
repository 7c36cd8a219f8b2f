"""Scans and sinks: entity snapshots, the message log, trace lines, recordings, test inputs."""
