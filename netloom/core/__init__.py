"""Building blocks shared by the operators: addresses, deliveries, ordered neighbours, exact ranks, shared tables."""
