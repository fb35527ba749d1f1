"""Helpers of the training-data operators."""

from quarrylight.operators.storage import cut

__all__ = ["cut"]
