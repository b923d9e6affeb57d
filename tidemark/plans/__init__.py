"""Whole runs: versioned state, cycles, plans shown, and the command line."""
