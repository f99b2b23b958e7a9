"""The operators as queries over the shared tables, each with its SQL counterpart."""
