"""Investigation of escalated alerts, set-based: no query per alert."""
