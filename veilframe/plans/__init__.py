"""Compositions of operators: copies, slices, paging, seeding, the full run."""
