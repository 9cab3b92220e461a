"""Readers, loaders and sinks for JSON documents."""
