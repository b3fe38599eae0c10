"""Relational and numeric operators over frames, events and tracks."""
