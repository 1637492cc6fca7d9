"""The six signals, their detail look-ups and the shared rollups."""
