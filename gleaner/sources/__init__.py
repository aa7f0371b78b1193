"""Readers and adapters that give (doc_id, url, title, body)."""
