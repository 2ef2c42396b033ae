"""Feeds. The batch operators take any DataFrame, so only what keeps state stands here."""
