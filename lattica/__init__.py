"""Relational analytics for Spark with the semantics of an Oracle-flavoured SQL dialect."""
