"""Registered queries and their oracle, ad-hoc SQL, question batches, the full rebuild."""
