"""Knowledge memory as DataFrame operators: observations, versioned facts, entities, edges and the questions over them."""
