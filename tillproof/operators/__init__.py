"""Operators over whole tables: profiling, cleaning, audit, star schema, metrics and checks."""
