"""Registered queries: the operators applied to the driver's tables, each with the SQL that it must agree with."""
