"""Writers, alert payloads, delivery and the stored-result table."""
