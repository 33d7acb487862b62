"""User-level jobs; the only modules that run actions on whole tables."""
