"""Readers and writers of listing and licence tables, and extraction from tables of web pages."""
