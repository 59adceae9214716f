"""Readers, writers and normalizers for bars and raw venue messages."""
