"""The invoice template: fields, zones and aliases in match order (fixed values)."""

TEMPLATE_VERSION = "invoice_v1"

#: field, zone, label, aliases
FIELDS = (
    ("vendor_name", "top_left", "Vendor/Shop Name", ("vendor/shop name", "vendor", "seller", "from", "company", "firm", "shop", "store", "biller", "issued_by", "supplier")),
    ("vendor_address", "top_left", "Address", ("address", "vendor_address", "seller_address", "from_address", "office_address")),
    ("vendor_gstin", "top_left", "Phone / Gstin / Tax Id", ("phone / gstin / tax id", "gstin", "gst", "gst_number", "gstin_number", "vendor_gstin", "seller_gstin", "tax_id")),
    ("vendor_phone", "top_left", "Phone / Gstin / Tax Id", ("phone / gstin / tax id", "phone", "mobile", "contact", "tel", "telephone", "vendor_phone")),
    ("vendor_email", "top_left", "Email", ("email", "e-mail", "vendor_email")),
    ("invoice_number", "top_right", "Bill No / Customer Id", ("bill no / customer id", "invoice_number", "invoice_no", "bill_number", "bill_no", "receipt_no", "challan_no", "ref_no")),
    ("invoice_date", "top_right", "Date", ("date", "invoice_date", "bill_date", "issued_date", "dated")),
    ("due_date", "top_right", "Due Date", ("due_date", "payment_due", "pay_by")),
    ("po_number", "top_right", "Po Number", ("po_number", "purchase_order", "order_number", "po_no")),
    ("buyer_name", "mid_left", "Buyer", ("buyer", "bill_to", "customer", "client", "consignee", "to", "billed_to", "sold_to")),
    ("buyer_address", "mid_left", "Buyer Address", ("buyer_address", "bill_to_address", "customer_address", "delivery_address")),
    ("buyer_gstin", "mid_left", "Buyer Gstin", ("buyer_gstin", "customer_gstin", "bill_to_gstin")),
    ("items", "center", "Items", ("items", "line_items", "products", "goods", "services", "description", "particulars")),
    ("subtotal", "bottom_right", "Subtotal", ("subtotal", "taxable_amount", "taxable_value", "net_amount", "before_tax")),
    ("cgst", "bottom_right", "Cgst", ("cgst", "central_gst", "cgst_amount")),
    ("sgst", "bottom_right", "Sgst", ("sgst", "state_gst", "sgst_amount")),
    ("igst", "bottom_right", "Igst", ("igst", "integrated_gst", "igst_amount")),
    ("total_tax", "bottom_right", "Total Tax", ("total_tax", "tax_total", "gst_total", "vat")),
    ("total_amount", "bottom_right", "Total Amount", ("total amount", "total", "grand_total", "total_amount", "net_total", "amount_due", "bill_total", "payable", "final_amount")),
    ("amount_in_words", "bottom_right", "Amount In Words", ("amount_in_words", "in_words", "rupees_in_words", "total_words")),
    ("bank_name", "bottom", "Bank", ("bank", "bank_name")),
    ("account_number", "bottom", "Account Number", ("account_number", "account_no", "acc_no", "bank_account")),
    ("ifsc", "bottom", "Ifsc", ("ifsc", "ifsc_code", "bank_ifsc")),
    ("upi", "bottom", "Upi", ("upi", "upi_id", "gpay", "phonepe")),
    ("notes", "footer", "Notes", ("notes", "terms", "conditions", "remarks", "note")),
)

ZONES = (
    ("top_left", "VENDOR / SELLER"),
    ("top_right", "INVOICE DETAILS"),
    ("mid_left", "BUYER / BILL TO"),
    ("center", "LINE ITEMS"),
    ("bottom_right", "TAX & TOTALS"),
    ("bottom", "PAYMENT INFO"),
    ("footer", "NOTES & TERMS"),
)
