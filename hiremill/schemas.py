"""Schemas of the engine's tables."""

from __future__ import annotations

PUBLISHED = "fingerprint string, title string, source string, url string"
HITS = "title string, link string, snippet string, date string"
