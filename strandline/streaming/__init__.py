"""Incremental loading of loci lists."""
