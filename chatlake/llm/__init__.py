"""Training-data pipeline operators; each module is one operator, ``queries`` holds the thin registered queries."""
