"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; its queries are gathered in
``stratalens.llm.queries``.
"""
