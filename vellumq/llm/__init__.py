"""Training-text operators; nothing outside this folder imports it."""
