"""Complete jobs, each a composition of the operators."""

from serieslake.plans import activity, exchange, ledger, monetary, prices, repo, trades

__all__ = ["activity", "exchange", "ledger", "monetary", "prices", "repo", "trades"]
