"""Training-data operators: text, vectors, pages and media at corpus scale.

Nothing outside this subpackage imports it.  Its registered queries are in
``tidepanel.llm.queries``.
"""
