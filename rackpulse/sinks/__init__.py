"""Writers of curated tables, points, alerts, models and exports."""
