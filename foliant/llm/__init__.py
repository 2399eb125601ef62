"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; ``foliant.llm.queries`` registers
its queries and ``corpus_pipeline.py`` chains five of its operators.
"""
