"""The one Python hop of a page: its facts as a struct, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = (
    "struct<title:string, lang:string, meta_charset:string, metas:array<struct<name:string, property:string, content:string>>, "
    "links:array<struct<rels:array<string>, stylesheet:boolean, type:string, hreflang:string, href:string, url:string>>, anchors:array<struct<href:string, url:string, in_nav:boolean>>, "
    "images:array<struct<alt:string, urls:array<string>>>, sources:array<struct<url:string, parent:string>>, media:array<string>, iframes:array<struct<url:string>>, "
    "scripts:array<struct<src:string, url:string>>, forms:int, blocks:array<struct<tag:string, text:string>>, "
    "jsonld:struct<types:array<string>, emails:array<string>, phones:array<string>, name:string, description:string, url:string, founding:string, phone:string, logo:string, location:string>, "
    "og_image_url:string, favicon:string, favicon_url:string, error:string>"
)
_FIELDS = ["title", "lang", "meta_charset", "metas", "links", "anchors", "images", "sources", "media", "iframes", "scripts", "forms", "blocks", "jsonld", "og_image_url", "favicon", "favicon_url", "error"]
_EMPTY = {"title": "", "lang": "", "meta_charset": None, "forms": 0, "jsonld": {k: None for k in ("name", "description", "url", "founding", "phone", "logo", "location")} | {"types": [], "emails": [], "phones": []}, "og_image_url": None, "favicon": "", "favicon_url": None}


@lru_cache(1)
def _udf():
    from webloom.functions.dom import page_facts

    def facts(html: str | None, base: str | None) -> dict:
        try:
            return page_facts(html or "", base or "")
        except Exception as e:  # a page never fails its task
            return {k: _EMPTY.get(k, []) for k in _FIELDS} | {"error": f"{type(e).__name__}: {e}"[:200]}

    @F.pandas_udf(PAGE)
    def parse(html: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([facts(h, b) for h, b in zip(html, base, strict=True)], columns=_FIELDS)

    return parse


def parse_page(html: Column, base_url: Column) -> Column:
    """Facts of a page; NULL and empty pages have empty facts, a page that can't be read its reason in ``error``."""
    return _udf()(html, base_url)
