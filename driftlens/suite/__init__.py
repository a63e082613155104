"""The registered queries: each operator applied to the given tables, with its SQL twin."""
