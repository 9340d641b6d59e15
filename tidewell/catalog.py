"""Every registered query with, where SQL can express it, the SQL that checks it."""

from tidewell.plans import audience, classify, feeds, gates, pages, ranking, reports, selection, streams, taste

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (ranking, audience, pages, gates, taste, selection, classify, feeds, reports, streams):
    QUERIES |= _module.CATALOGUE.queries
    ORACLES |= _module.CATALOGUE.oracles
