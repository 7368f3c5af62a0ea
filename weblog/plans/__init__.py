"""Query catalog (driver keys), the SQL surface, and plan inspection helpers."""
