from shelfcast.functions import exprs

__all__ = ["exprs"]
