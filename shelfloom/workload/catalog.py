"""All registered queries."""

from shelfloom.workload import feed, jobs, prompting, results, stored
from shelfloom.workload.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS", "feed", "jobs", "prompting", "results", "stored"]
