"""Writers. The functions here start Spark actions."""
