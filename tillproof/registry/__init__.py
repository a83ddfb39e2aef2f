"""Every registered query with its SQL counterpart."""
