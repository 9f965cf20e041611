"""Stateless operators on streams: cleaning, tokens, answers, predictions.

No operator here keeps state, so none needs a watermark or a state store.
"""
