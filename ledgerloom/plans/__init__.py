"""The query registry: named queries and the SQL they are checked against."""
