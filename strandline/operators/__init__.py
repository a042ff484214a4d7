"""Relational and kernel operators over the long pangenome tables."""
