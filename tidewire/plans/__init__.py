"""State tables and the plan of a run."""
