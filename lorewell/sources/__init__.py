"""Readers, writers and what a job needs from its surroundings."""
