"""Readers and writers of the file kinds the reports use."""
