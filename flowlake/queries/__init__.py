"""Registered queries and their SQL twins, by subject.

Every module has ``QUERIES`` (name -> function of session and table folder) and ``SQL``
(name -> text for the check engine).
"""
