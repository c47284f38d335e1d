"""Query builders and the catalog of collections."""
