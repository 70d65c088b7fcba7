"""The session of the core's tests serves these too."""
