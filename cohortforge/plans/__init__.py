"""The composite jobs (in-force build, survey funnel, consumer link) and the reports."""
