"""Immutable configuration, read on the driver, and the dimension tables made from it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from copy import deepcopy
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire import fixed_values as fixed

_KEYWORDS = T.StructType([T.StructField(n, t) for n, t in (("category", T.StringType()), ("key", T.StringType()), ("key_pos", T.IntegerType()), ("lang", T.StringType()), ("pos", T.IntegerType()), ("keyword", T.StringType()), ("n_words", T.IntegerType()))])


@dataclass(frozen=True)
class Config:
    """Settings with dotted access; ``document_types`` and ``document_sides`` keep their order, which decides ties."""

    values: Mapping[str, Any]

    @classmethod
    def default(cls) -> Config:
        ocr = {"primary_language": fixed.PRIMARY_LANGUAGE, "fallback_language": fixed.FALLBACK_LANGUAGE, "auto_detect_language": True, "language_detection_keywords": fixed.LANGUAGE_KEYWORDS}
        return cls(deepcopy({"document_types": fixed.DOCUMENT_TYPES, "document_sides": fixed.DOCUMENT_SIDES, "ocr_settings": ocr, **fixed.SETTINGS}))

    @classmethod
    def load(cls, path: str) -> Config:
        """Reads JSON as UTF-8; ``FileNotFoundError`` if there is none, ``ValueError`` if it can't be parsed."""
        with open(path, encoding="utf-8") as f:
            try:
                return cls(json.load(f))
            except json.JSONDecodeError as e:
                raise ValueError(f"{path} is no valid JSON: {e}") from e

    @classmethod
    def load_ocr_settings(cls, path: str) -> Mapping[str, Any]:
        """The file's OCR settings, or the default languages if they can't be had."""
        try:
            return cls.load(path).values["ocr_settings"]
        except (OSError, ValueError, KeyError, TypeError):
            return {"primary_language": fixed.PRIMARY_LANGUAGE, "fallback_language": fixed.FALLBACK_LANGUAGE, "auto_detect_language": True}

    def get(self, path: str, default: Any = None) -> Any:
        """A value by its dotted path."""
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, name: str) -> Mapping[str, Any]:
        return self.values.get(name, {})

    def enabled(self, category: str) -> dict[str, Any]:
        """Entries of ``document_types`` or ``document_sides`` that aren't switched off."""
        return {k: v for k, v in self.section(category).items() if v.get("enabled", True)}

    def keywords(self, category: str, key: str) -> dict[str, list[str]]:
        return dict(self.section(category).get(key, {}).get("keywords", {}))

    def all_keywords(self, category: str) -> dict[str, dict[str, list[str]]]:
        return {key: self.keywords(category, key) for key in self.section(category)}

    def flat_keywords(self) -> list[str]:
        return [k for c in ("document_types", "document_sides") for langs in self.all_keywords(c).values() for ks in langs.values() for k in ks]

    def aliases(self, category: str, key: str) -> list[str]:
        return list(self.section(category).get(key, {}).get("aliases", []))

    def label(self, category: str, key: str) -> str:
        return self.section(category).get(key, {}).get("label", key.upper())

    def display_name(self, category: str, key: str) -> str:
        return self.section(category).get(key, {}).get("display_name", key.upper())

    def color(self, key: str) -> tuple[int, int, int]:
        return tuple(self.section("document_types").get(key, {}).get("color", (128, 128, 128)))

    def short_code(self, key: str) -> str:
        return self.section("document_sides").get(key, {}).get("label", key[:1].upper())

    @property
    def languages(self) -> Mapping[str, list[str]]:
        return self.get("ocr_settings.language_detection_keywords", {})

    @property
    def primary_language(self) -> str:
        return self.get("ocr_settings.primary_language", fixed.PRIMARY_LANGUAGE)


def keyword_dim(spark: SparkSession, config: Config) -> DataFrame:
    """A row for each keyword of each type and side."""
    rows = []
    for category in ("document_types", "document_sides"):
        for key_pos, (key, langs) in enumerate(config.all_keywords(category).items()):
            for lang, words in langs.items():
                rows += [(category, key, key_pos, lang, pos, w, len(w.split())) for pos, w in enumerate(words)]
    return spark.createDataFrame(rows, _KEYWORDS)


def label_dim(spark: SparkSession, config: Config) -> DataFrame:
    """Label, display name, colour and short code of each type and side."""
    rows = [("document_types", k, config.label("document_types", k), config.display_name("document_types", k), list(config.color(k)), None) for k in config.section("document_types")]
    rows += [("document_sides", k, config.label("document_sides", k), config.display_name("document_sides", k), None, config.short_code(k)) for k in config.section("document_sides")]
    return spark.createDataFrame(rows, "category string, key string, label string, display_name string, color array<int>, short_code string")
