"""Alignment of the reading clock with the event clock."""
