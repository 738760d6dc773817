"""Queries and the SQL that says the same, by name."""

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, statement: str | None = None):
    def register(function):
        QUERIES[name] = function
        if statement:
            SQL[name] = statement
        return function

    return register
