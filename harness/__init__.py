"""The registered queries: the given tables in the roles the jobs expect."""
