"""Bringing points and circles in, generating them, and writing run traces out."""
