"""Registered queries: operators applied to tables, with SQL to hold them against."""
