"""Reading, writing, generating and fingerprinting tables."""
