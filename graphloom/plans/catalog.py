"""All queries of the core by name, and their SQL."""

from graphloom.plans import documents, frameworks, knowledge, problems, searches, store, walks

MODULES = (problems, store, walks, searches, knowledge, frameworks, documents)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: text for m in MODULES for name, text in m.ORACLE.items()}
