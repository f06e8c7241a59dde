"""Registers every query by importing the modules that define them."""

import importlib

for _name in ("views", "relational", "usage", "cleaning", "retrieval", "blocks", "questions", "sources", "streams"):
    importlib.import_module(f"scholia.plans.{_name}")
