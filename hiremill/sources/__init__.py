"""Readers and writers of payloads, feeds, pages, messages and ledgers."""
