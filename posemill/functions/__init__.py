"""Column functions: geometry of body landmarks, ids, bands and rules for single rows."""
