"""Readers, writers, staging, and the testdata role map."""
