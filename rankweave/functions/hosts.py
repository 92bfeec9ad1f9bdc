"""Host of a url as written in the wild: spacing, brackets, case, ``www.`` and a closing dot do not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[^\p{L}\p{N}]*(?:[A-Za-z][A-Za-z0-9+.-]*\s*:\s*[\\/]+)?(?:[^/?#@\s]*@)?([^/?#\\:\s>]+)"


def site_of(url: Column) -> Column:
    """Host in lower case without ``www.``; NULL for NULL or blank."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    host = F.regexp_replace(host, r"^(?:www\.)+|[^\p{L}\p{N}]+$", "")
    return F.when(host != "", host)
