"""Plans: Dataset, schemas, error policies."""
