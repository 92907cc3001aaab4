"""The Cypher front end: text to DataFrame."""
