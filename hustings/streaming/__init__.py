"""Windows, de-duplication and incremental refresh; the same code serves batch tables and streams."""
