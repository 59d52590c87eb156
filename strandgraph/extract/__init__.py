"""Fact extraction from source files, one table function per language."""
