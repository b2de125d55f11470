"""Jobs made of operators: curation, sync, and the checked queries."""
