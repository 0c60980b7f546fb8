"""Sources: CSV (S1, S2), threat feeds (S7-S12), packet captures."""
