"""The registered queries: package operators over the supplied tables, and their SQL counterparts."""
