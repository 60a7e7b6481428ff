"""Model tables: schemas, adapters from the star schema, and durable storage."""
