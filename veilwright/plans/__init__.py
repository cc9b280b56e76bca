"""Whole workflows: model stages as request and replay, and the plans that join stages to results."""
