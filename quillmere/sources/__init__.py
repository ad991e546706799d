
from . import code  # noqa: F401  registers the extractors of source code and filings
