"""Training-data operators: sharding, language ID, toxicity, packing, token counts,
LM scoring, chat formatting, decontamination and near-duplicate detection.

Nothing outside this subpackage imports it.
"""
