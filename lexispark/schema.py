"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from lexispark.operators.nested import TURNS

UTTERANCE = "id string, text string, audio_id string, audio_path string, normalized_text string, duration double, start double, end double, speaker string, gender string, split string"
CONVERSATION = f"id string, turns {TURNS}, dataset_name string, speaker string, language string, split string, metadata map<string,string>"
WORD = "word string, start double, end double, conf double"
DIARIZATION = "rec string, speaker string, start double, end double"
