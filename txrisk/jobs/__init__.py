"""Commands for spark-submit: ``python -m txrisk.jobs <command> --help``."""
