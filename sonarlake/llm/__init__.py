"""Operators for preparing training text: quality, toxicity, near copies, search, tokenizing, packing, archives, chats."""
