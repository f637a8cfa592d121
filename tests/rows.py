"""Helpers for rows in tests, in a module of their own: every test folder has a conftest."""


def column(df, name):
    return [row[name] for row in df.collect()]
