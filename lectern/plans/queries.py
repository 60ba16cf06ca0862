"""All registered queries of the course-knowledge operators."""

from lectern.plans import evaluation, ingest, ledgers, relational, stored, teaching  # noqa: F401
from lectern.plans.base import QUERIES, SQL  # noqa: F401
