"""Readers and writers of the files that ranker training exchanges."""
