"""Readers and writers of the pangenome file formats."""
