"""DataFrame operators: stock, sales, reports, parties, cart and change-apply jobs."""
