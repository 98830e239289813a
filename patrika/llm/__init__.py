"""Training-data operators: WARC files, token counts, mixing, quality, de-duplication, decontamination, toxicity, URLs.

Nothing else in the package imports this subpackage. Each module holds one operator; ``queries`` registers them.
"""
