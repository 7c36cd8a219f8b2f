"""Set-based operators on entity tables, the message log, traces and recordings."""
