"""Readers and writers for feeds, model requests and replies, pages and images."""
